"""Reading and writing tables: text files with the usual options, stored results, cursors, foreign tables."""
