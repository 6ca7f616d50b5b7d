"""cutlist: Spark jobs that plan short-form video at scale, on tables of clips, words and events."""
