"""Stored results that a day's rows, also late ones, bring up to date without a pass over all data.

Each store keeps one folder per load and writes it with an overwrite, so a load
that failed or is repeated replaces its own part and nothing else.
"""
