"""Operations of a training-data pipeline, as Spark jobs over a documents table."""
