"""Operations for preparing training corpora at scale."""
