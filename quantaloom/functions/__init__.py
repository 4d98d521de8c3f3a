"""quantaloom.functions"""
