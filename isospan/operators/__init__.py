"""Operators over country tables, panels, polygon frames and edge lists."""
