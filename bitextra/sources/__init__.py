"""bitextra.sources"""
