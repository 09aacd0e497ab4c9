"""CSV and workbook sources and the reconciled import into one table.

A source yields two tables.  ``profiles`` has one row per file with its header
cells.  ``cells`` has one row per record: the file, the block of the file, a
sequence number that grows by one inside the block, and the cells by position.
"""
