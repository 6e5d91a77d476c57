"""Operators on frames: contracts, staging, silver, marts, run statistics, coverage, profiles."""
