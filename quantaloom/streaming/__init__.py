"""quantaloom.streaming"""
