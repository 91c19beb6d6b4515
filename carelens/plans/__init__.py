"""Registered queries (``catalog``) and the equivalent DuckDB SQL (``oracle``)."""
