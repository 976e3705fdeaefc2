"""bitextra.plans"""
