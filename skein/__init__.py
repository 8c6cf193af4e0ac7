"""skein: DataFrame-in, DataFrame-out operators for document retrieval pipelines."""
