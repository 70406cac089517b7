"""Document-intelligence analytics on PySpark: ingestion, clustering, selection and
synthesis work-lists for news-style document streams, plus corpus-scale data cleaning."""
