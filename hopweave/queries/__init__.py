"""The library's operators applied to the driver tables, each query beside the SQL that states its result."""
