"""symloom.functions"""
