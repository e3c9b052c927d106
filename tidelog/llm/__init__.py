"""Operations of a training-data pipeline on tables of documents, vectors and pages."""
