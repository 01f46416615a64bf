"""brackenlake.sources"""
