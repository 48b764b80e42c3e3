"""Operations for preparing large training corpora (see README, section "Corpus operators")."""
