"""Operators over vertex and edge tables: ids, layouts, filters, algorithms."""
