"""stillwater.functions"""
