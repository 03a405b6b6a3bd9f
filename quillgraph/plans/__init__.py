"""From a question to the DataFrame that answers it."""
