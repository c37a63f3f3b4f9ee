"""mizan.streaming"""
