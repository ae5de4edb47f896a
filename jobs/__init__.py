"""Jobs that write tables: each is a function taking a session and plain paths, with a command line around it."""
