"""sparloom: text, document, graph, catalog and change analytics on PySpark."""
