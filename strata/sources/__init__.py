"""Scans and sinks of archives, specs, parameter files, key/value files and image layouts."""
