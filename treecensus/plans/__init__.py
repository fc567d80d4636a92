"""Reviewable action plans.

A plan is a table of (path, action, before, after ...).  Nothing here changes a
file system; applying a plan is left to other tools.
"""
