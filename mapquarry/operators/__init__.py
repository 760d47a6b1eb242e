"""Relational and graph operators over nodes, ways and relations."""
