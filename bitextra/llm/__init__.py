"""Operations that prepare bilingual records and documents as training data."""
