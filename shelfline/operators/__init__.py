"""``DataFrame -> DataFrame`` building blocks."""
