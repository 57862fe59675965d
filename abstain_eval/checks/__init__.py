"""Queries over the given tables and the DuckDB SQL that checks them."""
