"""glyphloom: multi-label text analytics as Spark plans."""
