"""Operations on training text: tokenising, duplicate search, filtering and sharding, as Spark jobs."""
