"""Table operators that SQL has no runnable statement for on files: DML, MERGE, joins by range and time, DDL effects."""
