"""mizan.sources"""
