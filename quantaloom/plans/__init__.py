"""quantaloom.plans"""
