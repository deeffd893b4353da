"""Operations on lists of entries."""
