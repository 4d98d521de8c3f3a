"""quantaloom.operators"""
