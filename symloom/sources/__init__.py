"""symloom.sources"""
