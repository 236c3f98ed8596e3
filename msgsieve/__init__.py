"""Message classification (ham / spam / phishing) as PySpark DataFrame jobs."""
