"""quern: episode curation, splitting, temporal features and audits on Apache Spark."""
