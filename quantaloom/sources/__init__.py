"""quantaloom.sources"""
