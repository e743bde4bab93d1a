"""stillwater.plans"""
