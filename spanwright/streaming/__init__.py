"""spanwright.streaming"""
