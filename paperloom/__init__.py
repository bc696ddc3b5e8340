"""paperloom: PDF-corpus analytics and text processing as PySpark DataFrame operators."""
