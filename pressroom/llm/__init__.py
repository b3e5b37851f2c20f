"""Operations of a training-data pipeline over `documents`, `benchmark`, `labels` and `pages`.

Nothing else in the package imports this subpackage; `queries` lists its registered queries."""
