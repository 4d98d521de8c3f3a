"""quantaloom: vector summaries, quantizers, integer codecs and linear models as Spark jobs."""
