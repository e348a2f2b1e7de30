"""symloom.streaming"""
