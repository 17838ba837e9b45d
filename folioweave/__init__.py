"""Set-at-a-time analytics over long documents, their summary trees, entity graphs and answers, on PySpark."""
