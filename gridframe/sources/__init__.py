"""Sources and sinks: CSV sheets (S1, S4), JSON records (S3, S5), workbook
folders (S2), file listings (S8, S9 live in ``operators.logs``)."""
