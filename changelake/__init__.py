"""changelake: change-data-capture streams as Spark DataFrames."""
