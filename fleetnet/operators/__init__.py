"""fleetnet.operators"""
