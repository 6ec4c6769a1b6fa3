"""Registered queries over the standard tables, with the SQL that checks them."""
