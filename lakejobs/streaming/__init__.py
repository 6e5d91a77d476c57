"""Micro-batch builds."""
