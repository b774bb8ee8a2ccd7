"""Registered queries and the plain SQL each is compared with."""
