"""sameas: entity resolution as Spark DataFrame jobs."""
