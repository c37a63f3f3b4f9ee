"""mizan.operators"""
