"""corpusloom: a Spark-native engine that prepares and audits text corpora."""
