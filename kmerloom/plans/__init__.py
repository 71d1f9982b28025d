"""Query catalogues: name -> DataFrame builder, and the SQL that each is held against."""
