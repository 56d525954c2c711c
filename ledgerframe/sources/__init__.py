"""Table sources: declared ERP schemas, Parquet lake and JDBC readers, lake writer, and the ERP test
tables derived from the generated TPC-H-style data."""
