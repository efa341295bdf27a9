"""Relational building blocks that stay exact and spread out when one key holds much of the data."""
