"""credence: confidence-weighted record retrieval, maintenance and text ETL on PySpark."""
