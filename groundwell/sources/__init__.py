"""Reading and writing: files, paged documents, JSON lines, run logs."""
