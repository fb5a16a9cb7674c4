"""Reading and writing: tables, file scans, snapshots, receipts."""
