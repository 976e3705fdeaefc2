"""bitextra.operators"""
