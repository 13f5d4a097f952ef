"""cadenza: music-catalogue analytics and experiment evaluation as Spark DataFrame jobs."""
