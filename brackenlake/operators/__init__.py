"""brackenlake.operators"""
