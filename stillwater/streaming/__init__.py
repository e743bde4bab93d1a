"""stillwater.streaming"""
