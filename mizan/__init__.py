"""mizan: set-at-a-time retrieval and evaluation over structured legal text, on Spark."""
