"""stillwater.operators"""
