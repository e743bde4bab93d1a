"""stillwater.sources"""
