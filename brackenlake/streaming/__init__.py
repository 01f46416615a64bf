"""brackenlake.streaming"""
