"""fleetnet.sources"""
