"""bitextra.streaming"""
