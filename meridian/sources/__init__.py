"""Files in and out: contracted reads, checked writes, and tables in the shared folder."""
