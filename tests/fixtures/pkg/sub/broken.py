def broken(:
    pass
class Ok:
    def m(self):
        pass
from x import y
