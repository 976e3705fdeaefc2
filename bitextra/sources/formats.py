"""Readers and writers of exchange formats, as plain generators over open files.

Every reader yields dicts with (a part of) source, target, context, created, modified, created_by, modified_by and
refcount; ``bitextra.sources.datasource`` makes Spark data sources of them, one file a task.  XML is parsed as a
stream, so a file's size is no limit.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

XML_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: fixed values: namespaces of the exchange formats
XLIFF_12, XLIFF_20 = "urn:oasis:names:tc:xliff:document:1.2", "urn:oasis:names:tc:xliff:document:2.0"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STAMP = "%Y%m%dT%H%M%SZ"
#: characters that XML cannot hold
_UNFIT = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ET.Element | None, deep: bool) -> str:
    """Text of an element; ``deep`` with all descendants, else of its direct children only."""
    if e is None:
        return ""
    if deep:
        return "".join(e.itertext())
    return (e.text or "") + "".join((c.text or "") + (c.tail or "") for c in e)


def _stamp(text: str | None) -> datetime | None:
    try:
        return datetime.strptime(text or "", STAMP)
    except ValueError:
        return None


def match_language(found: Iterable[str], wanted: str | None, strict: bool) -> str | None:
    """The language among ``found`` that ``wanted`` names: the same, or the same up to a region (``strict``) or a prefix."""
    if not wanted:
        return None
    wanted, dash = wanted.lower(), "-" if strict else ""
    found = list(found)
    if wanted in found:
        return wanted
    return next((k for k in found if k.startswith(wanted + dash) or wanted.startswith(k + dash)), None)


def _elements(f: BinaryIO, *names: str, drop: tuple[str, ...] = ()) -> Iterator[ET.Element]:
    """The elements of these local names as they end; they and those of ``drop`` then leave the tree, so it stays small."""
    path: list[ET.Element] = []
    for event, e in ET.iterparse(f, events=("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        name = _local(e.tag)
        if name in names:
            yield e
        if path and (name in names or name in drop):
            path[-1].remove(e)


def read_tmx(f: BinaryIO, source_lang: str | None = None, target_lang: str | None = None, flavour: str = "js", now: datetime | None = None) -> Iterator[dict]:
    """Translation units. 'js': context, regions by dash, languages kept from the first unit on, missing dates null.
    'py': languages by prefix, the target must differ from the source, both must have text, missing dates are ``now``."""
    js = flavour == "js"
    source_lang = source_lang.lower() if source_lang else None
    target_lang = target_lang.lower() if target_lang else None
    for e in _elements(f, "header", "tu"):
        name = _local(e.tag)
        if name == "header" and not source_lang and e.get("srclang"):
            source_lang = e.get("srclang").lower()
        if name != "tu":
            continue
        texts: dict[str, str] = {}
        for v in (x for x in e if _local(x.tag) == "tuv"):
            lang = (v.get(XML_LANG) or v.get("lang") or "").lower()
            if lang:
                texts[lang] = _text(next((x for x in v if _local(x.tag) == "seg"), None), deep=js)
        if len(texts) > 1:
            s = match_language(texts, source_lang, js)
            t = match_language(texts, target_lang, js)
            if not js:
                s = s if s and texts[s] else None
                t = t if t and texts[t] else None
            s = s or next(iter(texts))
            t = t or next((k for k in texts if (k != s if js else texts[k] != texts[s])), None)
            if t and (js or texts[s] and texts[t]):
                if js:
                    source_lang, target_lang = source_lang or s, target_lang or t
                context = next((_text(p, True) for p in e if _local(p.tag) == "prop" and (p.get("type") or "").lower() == "x-context"), "") if js else ""
                used = e.get("usagecount") or ""
                created, modified = _stamp(e.get("creationdate")), _stamp(e.get("changedate"))
                yield {
                    "source": texts[s], "target": texts[t], "context": context, "created": created or (None if js else now), "modified": modified or (None if js else now),
                    "created_by": e.get("creationid") or "", "modified_by": e.get("changeid") or "", "refcount": int(used) if used.isdigit() else 0,
                }


def read_xliff(f: BinaryIO) -> Iterator[dict]:
    """Units of version 1.2 and 2.0; units without a source are left out, a missing target is ''."""
    for e in _elements(f, "trans-unit", "segment", drop=("unit",)):
        part = {_local(x.tag): x for x in e}
        source = _text(part.get("source"), False)
        if source:
            yield {"source": source, "target": _text(part.get("target"), False)}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def read_xlsx(f: BinaryIO, source_col: int = 1, target_col: int = 2, sheet: str | None = None, header_row: int = 1) -> Iterator[dict]:
    """Rows below the header with text in either column; columns count from 1."""
    book = zipfile.ZipFile(f if f.seekable() else io.BytesIO(f.read()))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as s:
            for e in _elements(s, "si"):
                shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
    rels = {r.get("Id"): r.get("Target") for r in ET.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    sheets = [(s.get("name"), s.get(f"{{{RELS}}}id")) for s in ET.parse(book.open("xl/workbook.xml")).getroot().iter(f"{{{SHEET}}}sheet")]
    chosen = next((r for n, r in sheets if sheet is None or n == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet named {sheet}")
    path = rels[chosen].lstrip("/")
    with book.open(path if path.startswith("xl/") else f"xl/{path}") as rows:
        number = 0
        for e in _elements(rows, "row"):
            number = int(e.get("r") or number + 1)
            cells = {}
            for c in e:
                at = _column(c.get("r") or "") or len(cells) + 1
                inner = {_local(x.tag): x for x in c}
                if c.get("t") == "s" and "v" in inner:
                    cells[at] = shared[int(inner["v"].text)]
                elif c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif "v" in inner:
                    cells[at] = inner["v"].text or ""
            s, t = (cells.get(k, "").strip() for k in (source_col, target_col))
            if number > header_row and (s or t):
                yield {"source": s, "target": t}


# writers: each takes an iterator of record dicts


def _clean(text: str | None) -> str:
    return _UNFIT.sub("", text or "")


def write_tmx(f: BinaryIO, records: Iterable[dict], source_lang: str = "en", target_lang: str = "ja", flavour: str = "js") -> None:
    """TMX 1.4; absent attributes are left out. 'py' writes no context."""
    w = lambda s: f.write(s.encode())
    w('<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n')
    w(f'  <header creationtool="bitextra" creationtoolversion="0.1.0" datatype="plaintext" segtype="sentence" adminlang={quoteattr(source_lang.upper())} srclang={quoteattr(source_lang.upper())} o-tmf="bitextra"/>\n  <body>\n')
    for r in records:
        attrs = {"creationdate": r.get("created") and r["created"].strftime(STAMP), "changedate": r.get("modified") and r["modified"].strftime(STAMP), "creationid": r.get("created_by"), "changeid": r.get("modified_by"), "usagecount": r.get("refcount") and str(r["refcount"])}
        w("    <tu" + "".join(f" {k}={quoteattr(_clean(v))}" for k, v in attrs.items() if v) + ">\n")
        if flavour == "js" and r.get("context"):
            w(f'      <prop type="x-context">{_body(r["context"])}</prop>\n')
        for lang, text in ((source_lang, r.get("source")), (target_lang, r.get("target"))):
            w(f"      <tuv xml:lang={quoteattr(lang)}><seg>{_body(text)}</seg></tuv>\n")
        w("    </tu>\n")
    w("  </body>\n</tmx>\n")


def _body(text: str | None) -> str:
    # a carriage return would come back as a line feed
    return escape(_clean(text)).replace("\r", "&#13;")


def write_xliff(f: BinaryIO, records: Iterable[dict], source_lang: str = "en", target_lang: str = "ja", version: str = "1.2") -> None:
    """Version 1.2 or 2.0, ids from 1; the context becomes a note."""
    w = lambda s: f.write(s.encode())
    new = version.startswith("2")
    w('<?xml version="1.0" encoding="UTF-8"?>\n')
    if new:
        w(f'<xliff xmlns="{XLIFF_20}" version="2.0" srcLang={quoteattr(source_lang)} trgLang={quoteattr(target_lang)}>\n<file id="f1">\n')
    else:
        w(f'<xliff xmlns="{XLIFF_12}" version="1.2">\n<file source-language={quoteattr(source_lang)} target-language={quoteattr(target_lang)} datatype="plaintext" original="bitextra-export">\n<body>\n')
    for i, r in enumerate(records, 1):
        texts = f"<source>{_body(r.get('source'))}</source><target>{_body(r.get('target'))}</target>"
        note = f"<note>{_body(r['context'])}</note>" if r.get("context") else ""
        if new:
            w(f'<unit id="{i}">{f"<notes>{note}</notes>" if note else ""}<segment>{texts}</segment></unit>\n')
        else:
            w(f'<trans-unit id="{i}">{texts}{note}</trans-unit>\n')
    w("</file>\n</xliff>\n" if new else "</body>\n</file>\n</xliff>\n")


#: fixed values: columns of the spreadsheet and of the tab-separated file
SHEET_HEADER = ("Source", "Target", "Context", "Reliability", "Validated", "Ref Count", "Created", "Modified", "Created By", "Modified By")
TSV_HEADER = ("source", "target", "context", "reliability", "created", "modified", "validated")
_WIDTH_ROWS, _WIDEST = 101, 60


def _row(r: dict) -> list:
    date = lambda d: d.isoformat() if d else ""
    return [r.get("source") or "", r.get("target") or "", r.get("context") or "", r.get("reliability") or 0, "Yes" if r.get("validated") else "No", r.get("refcount") or 0, date(r.get("created")), date(r.get("modified")), r.get("created_by") or "", r.get("modified_by") or ""]


def write_xlsx(f: BinaryIO, records: Iterable[dict], source_lang: str = "Source", target_lang: str = "Target") -> None:
    """One sheet with a bold header, led by the two languages, and column widths from the first rows; rows are streamed."""
    names = "ABCDEFGHIJ"
    head: list[list] = [[source_lang, target_lang, *SHEET_HEADER[2:]]]
    it = iter(records)
    for r in it:
        head.append(_row(r))
        if len(head) == _WIDTH_ROWS:
            break
    widths = [min(_WIDEST, max(len(str(row[k])) for row in head) + 2) for k in range(len(SHEET_HEADER))]

    def cell(k: int, n: int, v, style: int) -> str:
        if isinstance(v, int):
            return f'<c r="{names[k]}{n}" s="{style}"><v>{v}</v></c>'
        return f'<c r="{names[k]}{n}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_body(v)}</t></is></c>'

    def rows() -> Iterator[list]:
        yield from head
        for r in it:
            yield _row(r)

    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        rel = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{rel}"><Relationship Id="r1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{rel}"><Relationship Id="r1" Type="{RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{RELS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{SHEET}" xmlns:r="{RELS}"><sheets><sheet name="Translation Memory" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{SHEET}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as s:
            s.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{SHEET}"><cols>{"".join(f"<col min={chr(34)}{k}{chr(34)} max={chr(34)}{k}{chr(34)} width={chr(34)}{w}{chr(34)} customWidth={chr(34)}1{chr(34)}/>" for k, w in enumerate(widths, 1))}</cols><sheetData>'.encode())
            for n, row in enumerate(rows(), 1):
                s.write(f'<row r="{n}">{"".join(cell(k, n, v, int(n == 1)) for k, v in enumerate(row))}</row>'.encode())
            s.write(b"</sheetData></worksheet>")

