"""Registry of checked queries and the inputs they run on."""
