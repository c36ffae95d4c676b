"""The operators applied to the star-schema test tables, with the SQL that checks them."""
