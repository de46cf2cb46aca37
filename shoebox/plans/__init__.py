"""Registered queries and the DuckDB SQL each one is checked against."""
