"""Spark-native data work around reasoning-based image-editing models.

Cleaning, export, sampling, sharding, segment building, token packing and
judge-score reporting, all as DataFrame-to-DataFrame functions.
"""
