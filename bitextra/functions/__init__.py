"""bitextra.functions"""
