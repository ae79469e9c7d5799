x = 1
