"""Compiled kernels: Java sources beside this file, built on the driver and sent to the executors as a jar.

The compiler is the one that Spark generates its own code with, so neither driver nor executors need anything more.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql.classic.column import Column as JavaColumn
from pyspark.sql.classic.column import _to_java_column, _to_seq

#: result type of each class
KERNELS = {"BlockScores": "array<struct<q:string,s:string,score:double>>", "CompareForm": "string"}
#: the functions, for the application that they were sent to
_sent: dict[str, dict] = {}


def _functions(sc: SparkContext) -> dict:
    """Compile and send the kernels, once per application."""
    app = sc.applicationId
    if app not in _sent:
        _sent.clear()
        jvm, loader = sc._jvm, sc._jsc.sc().getClass().getClassLoader()

        def array(kind, *items):
            made = sc._gateway.new_array(kind, len(items))
            for k, x in enumerate(items):
                made[k] = x
            return made

        def java(name: str):
            return loader.loadClass(f"org.apache.spark.sql.{name}")

        to = Path(tempfile.mkdtemp(prefix="bitextra-")) / "bitextra_kernels.jar"
        made = {}
        with zipfile.ZipFile(to, "w") as z:
            for name, kind in KERNELS.items():
                compiler = jvm.org.codehaus.janino.SimpleCompiler()
                compiler.setParentClassLoader(loader)
                compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
                for part, code in dict(compiler.getBytecodes()).items():
                    z.writestr(f"{part}.class", bytes(code))
                own = compiler.getClassLoader().loadClass(name)
                built = own.getDeclaredConstructor(array(jvm.java.lang.Class)).newInstance(array(jvm.java.lang.Object))
                # by reflection, as a call by name would take the variant for functions of unknown types
                udf = java("functions").getMethod("udf", array(jvm.java.lang.Class, own.getInterfaces()[0], java("types.DataType")))
                made[name] = udf.invoke(None, array(jvm.java.lang.Object, built, jvm.org.apache.spark.sql.types.DataType.fromDDL(kind)))
        sc._jsc.addJar(str(to))
        _sent[app] = made
    return _sent[app]


def call(name: str, *args: Column) -> Column:
    sc = SparkContext._active_spark_context
    return JavaColumn(_functions(sc)[name].apply(_to_seq(sc, args, _to_java_column)))
